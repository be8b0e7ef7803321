"""Session defaults and shared storage.

Nothing here sizes the cluster: partition counts and memory belong to the deployment. Only settings that results depend
on (time zone, ANSI mode) and the adaptive planner are fixed.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "corvane", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = RESULT_CONF | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir``.

    Only a session of one JVM (tests, benchmarks) may leave it unset; it gets a temporary folder. On a cluster executors
    couldn't reach such a folder, so that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


class _Scopes(threading.local):
    """Paths of the open ``scratch`` blocks of a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()
_LASTING: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_lasting() -> None:
    """Lazy results may read their tables until the program ends; then they go, if the session is still there."""
    for spark, path in _LASTING:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the end of the open ``scratch`` block, or else when the program ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    else:
        _LASTING.append((spark, path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage without depending on any executor staying alive, and keeps non-deterministic or costly inputs from being
    computed again by each consumer. Inside ``scratch`` the table goes when the block ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``stored``, for a result that outlives the current ``scratch`` block."""
    inner = _SCOPES.open.pop() if _SCOPES.open else None
    try:
        return stored(df, tag)
    finally:
        if inner is not None:
            _SCOPES.open.append(inner)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end; what is returned must be collected or ``kept``."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            _delete(spark, path)
