"""Session helpers: the shared folder of the cluster, written stage tables, local test sessions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and all runs on one machine (a local master, as in tests) a temporary folder is made and set. On a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def check_session(spark: SparkSession) -> None:
    """Raise, with what to do, where a session can't run the engine: no shared folder, another time zone than UTC, or adaptive execution off."""
    problems = []
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        problems.append("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        problems.append("set spark.sql.session.timeZone to UTC: months and days of scenes depend on it")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        problems.append("set spark.sql.adaptive.enabled to true: skewed joins are split by it")
    if problems:
        raise RuntimeError("; ".join(problems))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


#: Where written() notes its paths while collecting() is open.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that written() uses inside, so that drop() can free them once nothing reads them any more."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables; the list is empty afterwards."""
    while paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    This cuts the lineage: later stages read files which survive the loss of any executor.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
