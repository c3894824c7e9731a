"""Cut lineage so that a lost executor never forces a long recomputation."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``.

    Where none is set, a session on one machine (tests) takes a temporary
    folder; on a cluster that is an error, as executors would not see each
    other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    What is read has its real size for the planner.  A checkpoint() instead
    keeps the estimate of the plan that made it, which grows from round to
    round of an iteration until planning itself takes the time.
    ``clear_tables`` removes what was written so.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clear_tables(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results are written elsewhere."""
    ensure_checkpoint_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/tables")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
