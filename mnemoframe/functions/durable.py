"""Durable intermediate results of iterative operators, in the folder that the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that the context's checkpoint folder was set to.

    Without either, a session on one machine (tests) takes a temporary folder;
    on a cluster that is an error, as executors would not see each other's files.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and spark.sparkContext.master.partition("[")[0] == "local":
            shared = tempfile.mkdtemp(prefix="mnemoframe-")
        if shared is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def table_folder(spark: SparkSession) -> str:
    """A new folder for a table."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    A written table has its real size for the planner, where a checkpoint()
    keeps the estimate of the plan that made it; joined round by round such an
    estimate grows until planning itself takes the time.  ``clear_tables``
    removes what was written so.
    """
    folder = table_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clear_tables(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tables")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
