"""Point sets in Parquet, and splits written to and read from partitioned Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.model import POINTS, as_points


def read_vectors(spark: SparkSession, path: str, id_col: str, *coords: str) -> DataFrame:
    """points(id, coords) from a vector column or numeric columns of Parquet; reads only these."""
    return as_points(spark.read.parquet(path), id_col, *coords)


def literal(spark: SparkSession, rows: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame(rows, POINTS)


def save_splits(points: DataFrame, path: str) -> None:
    """points(id, coords, split) to Parquet, one folder a split. Replaces what is there, and fails where it can't write.

    Each call writes a run of its own; then a mark, an empty file whose name holds the run's number and folder, makes it the
    current one. So tables that read the run before still find it, and a run that fails changes nothing.
    """
    spark, run = points.sparkSession, uuid.uuid4().hex
    points.repartition("split").write.partitionBy("split").parquet(f"{path}/run-{run}")
    number, _ = current(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current-{number + 1:08d}-{run}")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(mark):
        raise OSError(f"{mark} is there already")


def current(spark: SparkSession, path: str) -> tuple[int, str]:
    """(number, folder) of the run that was marked last; of runs marked at once the one of greatest name; (0, "") without any."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current-*")
    marks = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    names = sorted(m.getPath().getName() for m in marks or [])
    if not names:
        return 0, ""
    _, number, run = names[-1].split("-")
    return int(number), f"{path}/run-{run}"


def read_splits(spark: SparkSession, path: str, *splits: int) -> DataFrame:
    """The splits asked for, or all, of the run that is the current one now; others are not read."""
    number, folder = current(spark, path)
    if not number:
        raise FileNotFoundError(f"no splits under {path}")
    df = spark.read.schema("id long, coords array<double>, split int").parquet(folder)
    return df.where(F.col("split").isin(*splits)) if splits else df
