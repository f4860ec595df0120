"""Tables that one operator writes for its own later steps.

A written table cuts the lineage: when an executor is lost, Spark reads the
files again instead of repeating the steps before them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder of this machine is set if Spark
    runs on this machine alone, as in tests; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Bytes of a batch that goes to Python at once, at most.
BATCH_BYTES = 2 << 20


def lean_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch, as rows that hold whole texts are large.

    A batch lies in memory several times, in the JVM and in Python. A session that
    asks for smaller batches keeps its own number. The setting stays, since results are
    made only when they are read; the rows per batch aren't touched.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_marked: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The tables of an application lie in one folder, which is deleted when it ends.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"
    if run not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(run)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(run)
    path = f"{run}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
