"""Session helpers of this subpackage: scratch tables, whole-table reads, free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import discard, scratch_path, shared_folder, written

__all__ = ["discard", "free_name", "id_type", "partitions", "scratch_path", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (case counts for nothing)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    """The type of an id column, for the schema of a result."""
    return df.schema[column].dataType.simpleString()
