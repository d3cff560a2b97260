"""Session, table reading and lineage cutting shared by every part of the engine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path may be anything Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in a session on one machine, as
    in a test, a folder is made and the setting filled in; on a cluster its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusledger-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The files live until :func:`drop_materialised` or until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.materialised_at = path
    return made


#: Spark's own bound on the bytes of a batch that goes to Python, and ours.
WIDE_BATCH, BATCH = "67108864b", 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The rows, whose session from now on hands Python batches of at most ``BATCH`` bytes, unless it has a bound of its own.

    A batch of texts is held in the JVM, in Python and again in what Python returns, for each task of an executor.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == WIDE_BATCH:
        conf.set(key, str(BATCH))
    return df


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` returned, once nothing reads it any more."""
    if getattr(df, "materialised_at", None):
        _delete(df.sparkSession, df.materialised_at)


def drop_materialised(spark: SparkSession) -> None:
    """Delete every table that this application has materialised."""
    _delete(spark, application_dir(spark))
