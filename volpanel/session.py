"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "volpanel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder that all executors share.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="volpanel-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never restarts an iteration from its first round."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on any store that Spark reads."""
    system, location = _file_system(spark, path)
    return system.exists(location)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    system, location = _file_system(spark, path)
    return [str(f.getPath().getName()) for f in system.listStatus(location)] if system.exists(location) else []


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that does not exist yet, at once with its content; False if it does.

    The content is written aside and moved into place by a rename that must not replace.
    """
    jvm = spark.sparkContext._jvm
    system, location = _file_system(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(aside, location, options)
        return True
    except Py4JJavaError as failed:
        system.delete(aside, False)
        if "FileAlreadyExistsException" in str(failed.java_exception.toString()):
            return False
        raise


def read_file(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    system, location = _file_system(spark, path)
    size = system.getFileStatus(location).getLen()
    stream = system.open(location)
    try:
        return "".join(chr(stream.read()) for _ in range(size))
    finally:
        stream.close()


def set_times_by_name(spark: SparkSession, path: str) -> None:
    """Give the files of a scratch folder modification times a second apart, in the order of their names."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is no scratch folder")
    system, location = _file_system(spark, path)
    found = sorted(str(f.getPath()) for f in system.listStatus(location))
    first = int(time.time()) - len(found)
    for i, name in enumerate(found):
        system.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), (first + i) * 1000, -1)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate folders made by ``scratch_path``; anything else is refused."""
    base = shared_dir(spark).rstrip("/") + "/"
    for path in paths:
        if not path.startswith(base):
            raise ValueError(f"{path} is no scratch folder")
        system, location = _file_system(spark, path)
        system.delete(location, True)
