"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "equiloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


#: Where a session in one process, such as a test's, keeps intermediate tables if it names no folder itself.
LOCAL_FOLDER = "/tmp/checkpoints/equiloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A session with executors of its own, ``local-cluster`` included, has to name a folder they all reach.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = LOCAL_FOLDER
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    files, place = _at(spark, path)
    files.delete(place, True)


def is_file(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.getFileStatus(place).isFile()


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    files, place = _at(spark, pattern)
    return [status.getPath().toString() for status in files.globStatus(place) or []]


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared one, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid4().hex}"
    files, place = _at(spark, path)
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later stages never recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
