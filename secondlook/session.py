"""Session helpers: a local session for tests and benches, and the shared folder for staged tables."""

import tempfile
import uuid
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: For tables of whole texts, which take two thirds of the room that Parquet's default takes.
TEXT_CODEC = "zstd"


def local_session(name: str = "secondlook", cpus: str = "*") -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder, because only there all tasks share
    one disk.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="secondlook-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/secondlook/{name}-{uuid.uuid4().hex}"


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a staged table, deleted with the run that it belongs to."""
    path = fresh_path(spark, name)
    for folders in _open_folders.get():
        folders.paths.append(path)
    return path


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so that lost executors do not repeat the work behind it (above all scoring
    calls), and gives the optimizer the real size of the table. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    files, at = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


class StagedFolders:
    """The folders that were staged inside a ``with`` block of this object, until ``remove`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._token = spark, [], None

    def __enter__(self) -> "StagedFolders":
        self._token = _open_folders.set((*_open_folders.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _open_folders.reset(self._token)

    def remove(self) -> None:
        while self.paths:
            remove_folder(self.spark, self.paths.pop())


_open_folders: ContextVar[tuple[StagedFolders, ...]] = ContextVar("open_folders", default=())
