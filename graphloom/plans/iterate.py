"""Lineage cuts for loops.

A loop that extends its own plan must cut lineage, or planning time grows with the
number of rounds. ``cut`` writes a reliable checkpoint: the files lie in the folder
the cluster names in ``spark.checkpoint.dir``, so a lost executor loses nothing. Loops
that join a state with itself use ``written``, a table in the same folder: a checkpoint
carries the estimated size of its plan, which such a join squares in each round, a table
has its true size. ``discard`` removes a table that no later step reads.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is named only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from shared storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def row_numbers(df: DataFrame, name: str, *order: Column, start: int = 1) -> DataFrame:
    """``df`` with the place of each row in a total order, by a distributed sort; only the tasks' row counts reach the driver."""
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["t"], r["n"]) for r in placed.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for t, n in counts:
        offsets.append((t, total))
        total += n
    ahead = F.broadcast(df.sparkSession.createDataFrame(offsets, "_task long, _ahead long"))  # a row per task
    return placed.withColumn("_task", task).join(ahead, "_task").withColumn(name, F.col("_ahead") + inside).drop("_task", "_ahead", "_at")


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
