"""Session, tables and the few physical helpers every operator shares.

Nothing here depends on the size of the data: broadcasts are taken only after
the side has been measured, lineage is cut only into shared storage, and input
splits are widened only when there are fewer of them than cores.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes, in the same way.
BROADCAST_BYTES = 64_000_000


def session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the operators expect."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kilnwork")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("KILNWORK_DRIVER_MEMORY", "8g"))
    )
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per context, so that they need no copy of their own.

    The archive is served by the driver like any Python file added to a context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kilnwork_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="kilnwork-"), "kilnwork_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("kilnwork", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._kilnwork_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``."""
    ship(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only where none is set."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kilnwork-ckpt-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on.

    The files survive the loss of executors, which a local checkpoint does not.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[object, str]] = []


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, as a parquet table: readers take only the columns they need, and its size in bytes is known to the planner.

    The tables of a session are deleted when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and they take at most ``most_bytes``; reads no more rows than that.

    The size in bytes is that of one row of the widest kind the schema allows for
    fixed columns, and of the longest values met for texts and arrays.
    """
    wide = [c for c, t in df.dtypes if t == "string" or t == "binary" or t.startswith(("array", "map", "struct"))]
    size = sum((F.coalesce(F.length(c), F.lit(0)) if t in ("string", "binary") else F.length(F.to_json(F.array(c)))) for c, t in df.dtypes if c in wide) if wide else F.lit(0)
    n, total = df.limit(limit + 1).select((size + 16 * len(df.columns)).cast("long").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= limit and total <= most_bytes


def join_measured(big: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``side`` broadcast if it was measured and is small, shuffled otherwise."""
    return big.join(F.broadcast(side) if small_enough(side, limit) else side, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores.

    Row counts do not matter here; a large table has more splits than cores and
    is left as it is.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
