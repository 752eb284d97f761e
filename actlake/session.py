"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for results or plans. A cluster's own values win: they are
# only applied to sessions created here.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "actlake", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; set one only where it is unset.

    The fallback folder is machine-local, so it is only taken on a local master.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="actlake-checkpoint-")
    context.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/actlake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: made once, read by column as often as needed."""
    spark = df.sparkSession
    path = work_path(spark, name)
    if _HELD.paths:
        _HELD.paths[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class _Held(threading.local):
    """Folders that ``stored`` wrote in this thread, by the ``released`` blocks that are open."""

    def __init__(self):
        self.paths: list[list[str]] = []


_HELD = _Held()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for ``df``, which is not read again."""
    from .sources.storage import remove

    remove(df.sparkSession, df._stored_at)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What jobs inside leave on disk goes when it is done with.

    Shuffle files go when their query ends, not when the driver next collects its garbage, and
    tables that ``stored`` wrote at the end of the block; what is to stay must be written elsewhere.
    """
    from .sources.storage import remove

    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    _HELD.paths.append([])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        for path in _HELD.paths.pop():
            remove(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
