"""The event log as a stream: follow commits, and keep a current state up to date.

Every commit of a store is a new folder of Parquet files, renamed into place, so
a file source sees whole transactions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.errors import Unsupported
from annalist.sources.store import LOG, Db


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of a store as they are committed."""
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path.rstrip('/')}/versions/")


def events(db: Db) -> DataFrame:
    """tx, event and data of every event, each once however often a file is seen."""
    if db.basis is not None:
        raise Unsupported("a historical view does not change")
    return log_stream(db.spark, db.path).where("kind = 'event'").select("tx", "event", "hash", "data").dropDuplicates(["event", "hash"])


def follow(db: Db, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Call ``each`` with the events of every micro-batch; the checkpoint makes it resume where it stopped."""
    writer = events(db).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replicate(source: Db, target: Db, checkpoint: str) -> StreamingQuery:
    """Apply a store's events to another one; replayed batches change nothing, since events are known by id and hash."""
    from annalist.sources.logs import apply

    def each(batch: DataFrame, _: int) -> None:
        lines = [r["data"] for r in batch.where("data IS NOT NULL AND tx > 64").orderBy("tx").toLocalIterator()]
        target.refresh()
        apply(target, lines)

    return follow(source, each, checkpoint, available_now=True)


def latest(changes: DataFrame) -> DataFrame:
    """The last value per entity of a stream of (e, v, tx), as a running aggregate."""
    return changes.groupBy("e").agg(F.max(F.struct("tx", "v")).alias("x")).select("e", F.col("x.v").alias("v"), F.col("x.tx").alias("tx"))
