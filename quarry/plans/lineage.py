"""Cutting lineage through tables written in the shared folder of the cluster.

``spark.checkpoint.dir`` names a folder every executor reaches, so what is written
there outlives the loss of an executor. Where it is unset (tests, a laptop) a
temporary folder of this machine is used, which is right in local mode only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """A folder of this application's own inside ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            base = own.get()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own_folder = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, own_folder, True)
            base = "file://" + own_folder
        _roots[app] = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, app)
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass


def _remove(spark: SparkSession, app: str) -> None:
    root = _roots.pop(app, None)
    if root is not None:
        _delete(spark, root)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later stages read the table, so neither a lost executor nor a second use makes
    Spark run the plan before it again. Its shuffle files go as soon as the table is written: else
    they stay until the driver happens to collect its garbage, which no amount of data makes it do.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def gathered(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of ``materialize`` with one schema, as one table."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._written for t in tables])


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads: the last round of an iteration.
    Other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_written", None):
            _delete(t.sparkSession, path)


def row_bytes(schema: T.StructType) -> int | None:
    """Bytes of a row in memory where all columns are of fixed width, else None."""
    if any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in schema.fields):
        return None
    return 16 + 8 * len(schema.fields)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` are at most ``limit`` and come to at most
    ``max_bytes``; else leave the choice to the planner, which shuffles.

    Bytes are rows times their width; with texts or arrays among the columns the width is not
    known, and the planner's estimate of the size (of the written file for a table) counts
    threefold, for compression."""
    if rows > limit:
        return df
    width = row_bytes(df.schema)
    size = rows * width if width else 3 * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df
