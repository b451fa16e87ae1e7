"""New documents as a stream into a table of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.tables import upsert


def stream_documents(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """JSON files that arrive in a folder, at most so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def append_to_table(rows: DataFrame, table: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch transformed and upserted into a versioned folder: the next version is written beside the latest and then
    named in LATEST with the stream (its checkpoint) and batch that made it. A batch that is run again after a failure starts from
    the version before its own; a new stream, whose batches count from 0 again, goes on from the latest."""
    spark = rows.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(table).getFileSystem(spark._jsc.hadoopConfiguration())
        before, stream, made = _latest(spark, table) or (0, "", -1)
        if stream == checkpoint and made >= batch_id:
            return  # named already: the failure came after the commit
        new = transform(batch)
        if before:
            new = upsert(spark.read.parquet(f"{table}/v{before}"), new, keys)
        new.write.mode("overwrite").parquet(f"{table}/v{before + 1}")
        out = fs.create(hadoop(f"{table}/LATEST.new"), True)
        out.writeInt(before + 1)
        out.writeUTF(checkpoint)
        out.writeLong(batch_id)
        out.close()
        fs.delete(hadoop(f"{table}/LATEST"), False)
        fs.rename(hadoop(f"{table}/LATEST.new"), hadoop(f"{table}/LATEST"))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, table: str) -> tuple[int, str, int] | None:
    """(version, stream, batch) named last; the new name counts where a failure came between dropping the old one and the change."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(table).getFileSystem(spark._jsc.hadoopConfiguration())
    at = next((p for p in (f"{table}/LATEST", f"{table}/LATEST.new") if fs.exists(hadoop(p))), None)
    if at is None:
        return None
    stream = fs.open(hadoop(at))
    try:
        return stream.readInt(), stream.readUTF(), stream.readLong()
    finally:
        stream.close()


def read_table(spark: SparkSession, table: str) -> DataFrame:
    found = _latest(spark, table)
    if found is None:
        raise FileNotFoundError(table)
    return spark.read.parquet(f"{table}/v{found[0]}")
