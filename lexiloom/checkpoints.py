"""Tables in the folder that all executors share, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of the tables written here: what a writer holds, and the least that a reader's task takes.
GROUP_BYTES = 1 << 24

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends. Only in local mode, on one machine, a temporary folder can stand in for it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def shared_table(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write once, read back; removed when the session ends. Survives lost executors.

    ``few``: two tasks a core at most write, each several shuffled parts one after the other, since making a file may start processes.
    """
    path = shared_folder(df.sparkSession, name)
    if few:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
