"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


# A generated method above 8,000 bytes of bytecode is left interpreted by the JVM. Plans with
# many expressions then run several times faster as separate smaller methods.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def tuned(spark: SparkSession) -> SparkSession:
    """Set the method limit unless the session has its own value."""
    name, default, wanted = METHOD_LIMIT
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, wanted)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are found by module name there, wherever the
    driver was started and whatever is installed on the workers.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="cohortlens-"), "cohortlens.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    path = os.path.join(folder, name)
                    if name.endswith(".py"):
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def build_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tuned(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="cohortlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read on from there, column by column.

    ``release`` removes what was written; what is still there when the driver ends is removed then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    application = spark.sparkContext.applicationId
    if application not in _written:
        atexit.register(_release_quietly, spark)
    _written.setdefault(application, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> int:
    """Delete what ``materialize`` wrote for ``frames``, or in this application; they are void then."""
    written = _written.get(spark.sparkContext.applicationId, [])
    files = [name for frame in frames for name in frame.inputFiles()]
    paths = [p for p in written if not frames or any(p.rsplit("/", 1)[1] in name for name in files)]
    for path in paths:
        written.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def _release_quietly(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)
