"""Structured Streaming jobs. Each runs through what is available and then stops.

A job keeps its progress in a checkpoint folder; running it again with the
same folder takes only what has arrived since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.schema import INDEX_SCHEMA, TREATMENT
from doseframe.streaming.protocol import REPLAY_SCHEMA, STATE_KEY, EpisodeProtocol, early_actions
from doseframe.operators.episodes import default_turns

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_signature_filter(de: DataFrame, signatures: DataFrame, out: str, checkpoint: str) -> None:
    """Append the rows of signature genes to ``out`` as they arrive."""
    genes = signatures.select("signature", F.col("gene").alias("gene_name")).distinct()
    query = (
        de.join(genes, "gene_name")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_first_seen(de: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the treatment index up to date: lowest file number per treatment.

    The state is one row per treatment. Each batch is pre-aggregated before
    its shuffle, and only the treatments that it changes are written below
    ``out``, under the batch number, so a repeated batch rewrites the same folder.
    ``compact_first_seen`` merges what has gathered.
    """
    index = de.groupBy(*TREATMENT).agg(F.min("file_num").cast("int").alias("file_num"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        index.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_first_seen(spark: SparkSession, out: str) -> DataFrame:
    """The index as of the last batch: the lowest number over all changes."""
    changes = spark.read.schema(INDEX_SCHEMA).option("recursiveFileLookup", "true").parquet(out)
    return changes.groupBy(*TREATMENT).agg(F.min("file_num").alias("file_num"))


def compact_first_seen(spark: SparkSession, out: str, target: str) -> None:
    """Write the merged index to ``target``, a new folder that later batches can go on in."""
    read_first_seen(spark, out).write.parquet(f"{target}/batch=-1")


def stream_replay(
    log: DataFrame, out: str, checkpoint: str, budget: int = 10, max_turns: int | None = None
) -> None:
    """Outcome of every action as it arrives; the state is a few counters per episode.

    Batches must bring an episode's actions in order of time; within a batch
    any order will do. An action from before the last one of an earlier batch is
    refused as ``out_of_order`` and takes no turn; beyond the earliest actions of its task
    it is refused as any action after the last turn is. The shuffle brings an
    episode's state at most ``max_turns`` actions per task.
    """
    if log.sparkSession.conf.get(STATE_STORE) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB}, as build_session does")
    turns = max_turns or default_turns(budget)
    query = (
        early_actions(log, turns)
        .groupBy(*STATE_KEY)
        .transformWithStateInPandas(
            statefulProcessor=EpisodeProtocol(budget, turns),
            outputStructType=REPLAY_SCHEMA,
            outputMode="append",
            timeMode="none",
        )
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
