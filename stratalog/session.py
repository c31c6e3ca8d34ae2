"""Session helpers: reading tables, cutting lineage, small bounded scalars."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table; a single file and a folder of part files are read alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set and the master is local (tests).

    Spark takes ``spark.checkpoint.dir`` for the context by itself when it is in the
    configuration at start; the setting is read again here for sessions that got it later.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "stratalog-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and returns a frame that reads it from there.

    Used where a result is needed by more than one consumer; the files survive lost executors.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def application_folder(spark: SparkSession) -> str:
    """A folder of the application in the checkpoint folder; it is deleted when the driver ends."""
    home = f"{checkpoint_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_delete, spark, home)
    return home


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the checkpoint folder: for wide rows that are read more than once, by column."""
    path = f"{application_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_homes: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    except Exception:  # the session has ended before: nothing more can be done from here
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes a session fit: sends this package to the Python workers, once an application, unless PYTHONPATH has it for them, and sets the zone to UTC."""
    home = Path(__file__).resolve().parent
    paths = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if home.parent not in paths and context.applicationId not in _shipped:
        packed = Path(tempfile.mkdtemp()) / f"{home.name}.zip"
        with zipfile.ZipFile(packed, "w") as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, file.relative_to(home.parent))
        context.addPyFile(str(packed))
        _shipped.add(context.applicationId)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":  # times without a zone are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """The session of tests and of bench.py."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratalog")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
