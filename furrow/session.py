"""Session defaults, and cutting of lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def get_spark(app: str = "furrow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent a local master gets an own temporary folder, removed at exit. A cluster has no folder to fall back on:
    that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.TemporaryDirectory(prefix="furrow-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _OWN[app] = "file://" + folder.name
    return _OWN[app]


_LOCAL = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written by ``cut`` inside the block are deleted at its end, except those cut with ``keep=True``, which belong to the block
    around it. The block's result must be such a table: what still reads a deleted one would fail."""
    scopes = _LOCAL.__dict__.setdefault("scopes", [])
    mine: list[tuple[SparkSession, str]] = []
    scopes.append(mine)
    try:
        yield
    finally:
        scopes.pop()
        for spark, path in mine:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back.

    The result survives the loss of executors, is never computed twice, and starts a new plan. Parquet is several
    times smaller than the row format of ``checkpoint()``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _LOCAL.__dict__.get("scopes", [])
    if len(scopes) > keep:
        scopes[-2 if keep else -1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


MOST_BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, and the join is left to Catalyst."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files are smaller than one piece per core: a small table may be a single row group, which Spark cannot
    split. Larger tables are read in enough pieces and stay as they are. For steps that compute much per row."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    piece = 128 << 20
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * piece
    return df.repartition(cores) if small else df


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however many later columns read them: as the one row of a generator they aren't copied
    into those."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("_one")).select(*df.columns, "_one.*")
