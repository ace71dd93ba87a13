"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without it a session in one process gets a temporary folder; a cluster gets an error, as its machines share none."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def persisted(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, for what several branches read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of a store; each holds all sources of one hash.
BUCKETS = 256
#: Rows of a store's files.
FILE_ROWS = 1_000_000


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def _bucket(source_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(buckets)).cast("int")


def write_by_source(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Puts rows with ``source_id`` into a store; sources that are there already are replaced, others stay.

    The store has a folder for each of ``buckets`` hashes, and in it files ordered by source, so that a source is found
    by its folder and the least and greatest id of each part of a file.  Only folders that a given source falls in are
    written anew.  Rows are dealt by ranges, so a source of any size is spread over several tasks and files.
    """
    spark = rows.sparkSession
    given = persisted(rows.withColumn("bucket", _bucket(F.col("source_id"), buckets)))
    if path_exists(spark, path):
        touched = F.broadcast(given.select("bucket").distinct())  # no more rows than folders
        old = spark.read.schema(given.schema).parquet(path).join(touched, "bucket", "left_semi").join(given.select("source_id").distinct(), "source_id", "left_anti")
        given = persisted(given.unionByName(old))  # read whole before its folders are replaced
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = given.withColumn("_no", F.monotonically_increasing_id()).repartitionByRange(parts, "bucket", "source_id", "_no").sortWithinPartitions("bucket", "source_id", "_no").drop("_no")
    spread.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").partitionBy("bucket").parquet(path)


def read_source(spark: SparkSession, path: str, schema: str, source_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one source (none if it isn't there), from its folder alone."""
    rows = spark.read.schema(f"{schema}, source_id string, bucket int").parquet(path)
    return rows.where((F.col("bucket") == _bucket(F.lit(source_id), buckets)) & (F.col("source_id") == source_id)).drop("bucket")


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a store."""
    return spark.read.schema(f"{schema}, source_id string, bucket int").parquet(path).drop("bucket")


def corpus_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, length, content of the files that ``glob`` names, empty ones left out."""
    return spark.read.format("binaryFile").load(glob).where("length > 0").select("path", "length", "content")


def pack_files(files: DataFrame, path: str) -> None:
    """Writes files (path, content) of some kilobytes each into containers, which are Parquet files, so that a corpus of millions costs the file system no more than its size does."""
    files.select("path", "content").write.parquet(path)


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files in the containers of a folder, empty ones left out."""
    length = F.length("content").cast("long")
    return spark.read.schema("path string, content binary").parquet(path).where(length > 0).select("path", length.alias("length"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """content_id, path, page, text: the pages of files (path, content), as text.

    The id is of the bytes.  Bytes that are no UTF-8 become replacement characters, a byte order mark goes, lines end with
    \\n, and form feeds part the pages, from 1.
    """
    text = tx.normalized(F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.select(F.substring(F.sha2("content", 256), 1, 16).alias("content_id"), "path", F.posexplode(F.split(text, "\f")).alias("no", "text"))
    return rows.select("content_id", "path", (F.col("no") + 1).alias("page"), "text")
