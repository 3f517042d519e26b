"""Shared working folder: cutting lineage with tables that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths written by ``stage`` and not yet removed, in order.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's; a local session without either gets a temporary one.

    On a cluster one of the two must be set, as executors don't see each other's disks.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="repeatloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that is removed when the driver ends, if not before."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; survives lost executors, ends the lineage."""
    spark = df.sparkSession
    path = new_path(spark, "staged")
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    return len(_written)


def remove_staged(spark: SparkSession, since: int) -> None:
    """Remove what was staged since ``staged_so_far()`` gave that number; nothing may read it any more."""
    while len(_written) > since:
        remove(spark, _written.pop())


#: Nodes of a plan below which a row's place is the same in every reading of its files.
_STEADY = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation"}


def replayable(df: DataFrame) -> DataFrame:
    """df, if its partitions hold the same rows in the same order whenever they are computed; else staged.

    That is so for projections and filters of files. After an exchange a recomputed
    partition may come in another order, and what was numbered by place would not agree.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in _STEADY:
        node = node.children().head()
    steady = node.children().size() == 0 and (node.nodeName() in _STEADY or node.nodeName().startswith("Relation"))
    return df if steady else stage(df)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows, from which block and bucket counts are derived."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts(total: int, each: int) -> int:
    return max(1, -(-total // each))


#: Rows that one sender deals to receivers, at most. With more receivers, rows go by way of
#: nodes that gather the rows of FAN senders for a share of the receivers and deal them on,
#: so that the number of rows grows with the input and not with its square.
FAN = 4096


def levels(n: int) -> tuple[int, int]:
    """(coarse, fine) for n receivers or a few more: a sender deals to coarse ones, each of which deals to fine ones; fine is 1 up to FAN."""
    fine = parts(n, FAN)
    return parts(n, fine), fine
