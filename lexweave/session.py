"""What operators need of the session: the shared folder, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a session in one process (``local[...]``, as in tests) gets a
    temporary folder, which goes when Python ends; any other session is refused,
    since its executors couldn't read each other's local files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lexweave-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = _own[0]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`written` that no later plan reads."""
    spark = df.sparkSession
    folder = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder in at:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
