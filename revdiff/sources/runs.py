"""Tables that are written in runs: a run counts as a whole or not at all, and may be repeated.

Under one path, ``<table>/stored_run=<id>`` holds what a run wrote, and ``_commits/<number>`` names the runs that
count, in order. A run is written first and named last, by creating one file that mustn't exist yet. So a
job that was stopped leaves nothing that is read, and the same run may be written again.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = re.compile(r"^(\d{10})$")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where Spark runs on this machine alone and none is set, as in tests, a temporary one is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Bytes of a batch that goes to Python at once, at most.
BATCH_BYTES = 4 << 20


def lean_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch, as pages and files are large and lie in memory several times; it stays, since results are made only when they are read."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``own_folder`` gave."""
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[str]:
    """The runs that count, oldest first; a run that stands for all before it hides these."""
    files, at = _files(spark, f"{path}/_commits")
    if not files.exists(at):
        return []
    found: list[str] = []
    for name in sorted(s.getPath().getName() for s in files.listStatus(at) if _COMMIT.match(s.getPath().getName())):
        stream = files.open(_files(spark, f"{path}/_commits/{name}")[1])
        try:
            kind, run = bytes(stream.readAllBytes()).decode().split(" ", 1)
        finally:
            stream.close()
        found = [run] if kind == "all" else [r for r in found if r != run] + [run]
    return found


def _commit(spark: SparkSession, path: str, kind: str, run: str) -> None:
    number = 0
    while True:
        files, at = _files(spark, f"{path}/_commits/{number:010d}")
        if not files.exists(at):
            try:
                stream = files.create(at, False)  # fails if another writer was first
            except Py4JJavaError:
                if not files.exists(at):
                    raise
            else:
                stream.write(f"{kind} {run}".encode())
                stream.close()
                return
        number += 1


def write_run(tables: dict[str, DataFrame], path: str, run: str | None = None, *, replaces_all: bool = False) -> str:
    """Write ``tables`` as one run and make it count. Returns its id.

    ``run``: an id of letters, digits, ``-`` and ``_``; a run of the same id is written over, unless it counts already, which is
    an error. With ``replaces_all`` all runs before it no longer count.
    """
    run = run or uuid.uuid4().hex
    if not re.fullmatch(r"[\w-]+", run):
        raise ValueError(f"not a run id: {run!r}")
    spark = next(iter(tables.values())).sparkSession
    if run in committed(spark, path):
        raise ValueError(f"run {run} counts already")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/stored_run={run}")
    _commit(spark, path, "all" if replaces_all else "run", run)
    return run


def read_runs(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """All rows of a table in the runs that count, with ``run_no``, which rises from run to run. ``schema`` has neither that name nor ``stored_run``."""
    runs = committed(spark, path)
    numbers = spark.createDataFrame([(r, i) for i, r in enumerate(runs)], "stored_run string, run_no int")
    if not runs:
        return spark.createDataFrame([], schema).withColumn("run_no", F.lit(0))
    reader = spark.read.schema(f"{schema}, stored_run string").option("basePath", f"{path}/{table}")
    return reader.parquet(*(f"{path}/{table}/stored_run={r}" for r in runs)).join(F.broadcast(numbers), "stored_run").drop("stored_run")


def last_of_each(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """``keys`` and ``run_no``: the last run that has each key, in a row where ``where`` holds."""
    return (rows.filter(where) if where is not None else rows).groupBy(*keys).agg(F.max("run_no").alias("run_no"))
