"""Session building and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``. Only a local master may do without (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = tempfile.mkdtemp(prefix="treeline-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, batch: str = "8m", by: str | None = None, records: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    What a Python worker gets at once while it is written stays near ``batch`` bytes, however long the rows are. With ``by``
    each value of that column has a folder; files have at most ``records`` rows, if that is given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_BATCH)
    spark.conf.set(ARROW_BATCH, batch)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", records).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(ARROW_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, without a job more."""
    seen = Observation()
    out = written(df.observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def release(*tables: DataFrame, collect: bool = False) -> None:
    """Delete what ``written`` wrote, once every reader of these tables has been written itself.

    With ``collect`` the driver collects its garbage too, Python's first, which may hold plans: only then does Spark drop the
    shuffle files and broadcasts of jobs that are done, and a driver that plans many small jobs keeps its heap small.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if collect and tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def local_session(app: str = "treeline", cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
