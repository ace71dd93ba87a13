"""Incremental jobs: new sources without duplicates, latest decisions.

Each runs over what has come since its last run (``availableNow``) and returns its
state as a table.  Its folder holds the checkpoint, so that a run resumes where the
last one ended, and the keyed state: what each batch changed (a delta), and a snapshot
of one row a key after every ``COMPACT`` batches.  A batch reads the last snapshot and
the deltas since, which are fewer than ``COMPACT``; older ones are deleted.  A batch
that is run twice writes the same folders again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete_path, folder_names, shared_folder


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for a job, in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Batches from one snapshot to the next.
COMPACT = 8


def _table(spark: SparkSession, path: str, files_a_batch: int | None) -> DataFrame:
    """A stream over the files of a table that may be one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{folder}/{name}*")


def state_paths(at: str, before: int, compact: int) -> list[str]:
    """Folders that hold the state before batch number ``before``: a snapshot, if there is one, and the deltas since."""
    snapshot = before // compact
    return ([f"{at}/snapshot/{snapshot:08d}"] if snapshot else []) + [f"{at}/delta/{n:08d}" for n in range(snapshot * compact, before)]


def _state(session: SparkSession, at: str, schema: str, before: int, compact: int) -> DataFrame:
    paths = state_paths(at, before, compact)
    return session.read.schema(schema).parquet(*paths) if paths else session.createDataFrame([], schema)


def _run(rows: DataFrame, at: str, schema: str, find, merge, compact: int) -> DataFrame:
    """Runs ``find(batch, state before)``, which gives the delta, over new batches; returns ``merge`` (one row a key) of the state."""

    def add(batch: DataFrame, no: int) -> None:
        session = batch.sparkSession
        find(batch, _state(session, at, schema, no, compact)).write.mode("overwrite").parquet(f"{at}/delta/{no:08d}")
        if (no + 1) % compact == 0:
            whole = _state(session, at, schema, (no + 1) // compact * compact - compact, compact)
            deltas = session.read.schema(schema).parquet(*[f"{at}/delta/{n:08d}" for n in range(no + 1 - compact, no + 1)])
            merge(whole.unionByName(deltas)).write.mode("overwrite").parquet(f"{at}/snapshot/{(no + 1) // compact:08d}")
            # the last snapshot but one and its deltas stay, in case this batch is run again
            for n in range(max(0, no + 1 - 3 * compact), no + 1 - 2 * compact):
                delete_path(session, f"{at}/delta/{n:08d}")
            if no + 1 > 2 * compact:
                delete_path(session, f"{at}/snapshot/{(no + 1) // compact - 2:08d}")

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    session = rows.sparkSession
    done = max([int(n) for n in folder_names(session, f"{at}/delta") if n.isdigit()], default=-1) + 1
    return merge(_state(session, at, schema, done, compact))


def source_stream(spark: SparkSession, documents: str, folder: str | None = None, compact: int = COMPACT, files_a_batch: int | None = None) -> DataFrame:
    """content_id, first_id: documents by content, each content once, with the least id of the batch that it first came in."""
    rows = _table(spark, documents, files_a_batch).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))

    def new(batch: DataFrame, before: DataFrame) -> DataFrame:
        return batch.groupBy("content_id").agg(F.min("doc_id").cast("long").alias("first_id")).join(before.select("content_id"), "content_id", "left_anti")

    return _run(rows, folder or fresh_folder(spark), "content_id string, first_id long", new, lambda state: state, compact)


def decision_stream(spark: SparkSession, events: str, folder: str | None = None, compact: int = COMPACT, files_a_batch: int | None = None) -> DataFrame:
    """source_id, decision, updated_at: the latest decision of each source; ties by event id. Out-of-order events lose."""
    kind = F.col("event_type")
    decision = F.when(kind.isin("purchase", "signup"), "approved").when(kind == "click", "held").when(kind == "error", "discarded").otherwise("pending")
    rows = _table(spark, events, files_a_batch)
    ts = rows.schema["ts"].dataType.simpleString()
    rows = rows.select(F.col("user_id").cast("string").alias("source_id"), F.struct("ts", F.col("event_id").cast("long").alias("event_id"), decision.alias("decision")).alias("last"))
    latest = lambda df: df.groupBy("source_id").agg(F.max("last").alias("last"))
    found = _run(rows, folder or fresh_folder(spark), f"source_id string, last struct<ts: {ts}, event_id: bigint, decision: string>", lambda batch, before: latest(batch), latest, compact)
    return found.select("source_id", "last.decision", F.col("last.ts").alias("updated_at"))
