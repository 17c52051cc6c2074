"""Session construction, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_STAGES: list[str] = []


def build_session(app: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; ``conf`` overrides any of them."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; column pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the folder set by ``setCheckpointDir``.

    Where neither is set, a session of one machine gets a folder of its own; on a cluster that is an error, as no executor could read what
    another one wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


def staged(df: DataFrame, columns_hint: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a cut of the lineage that outlives executors.

    Unlike ``checkpoint()`` the plan is run once, not twice. The folder is removed at the end of the innermost :func:`stage_scope`, else when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{columns_hint}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged within it: for jobs that go on, such as a stream's micro-batches."""
    begin = len(_STAGES)
    try:
        yield
    finally:
        for path in _STAGES[begin:]:
            _remove(spark, path)
        del _STAGES[begin:]


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _STAGES:
        _remove(spark, path)


atexit.register(_remove_all)


def _remove(spark: SparkSession | None, path: str) -> None:
    if path.startswith("file:") or path.startswith("/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    if "://" not in path:
        return os.path.exists(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
