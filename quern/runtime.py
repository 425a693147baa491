"""Session helpers: shared scratch tables that cut lineage, and size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def session(app: str = "quern", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    ``keep`` writes a frame once and reads it back: the plan behind it is cut and,
    unlike checkpoint(), its last stage runs once and the copy is compressed. A frame that
    the optimizer puts at no more than ``local_bytes`` is fetched instead, up to
    ``local_rows`` rows, and kept in the plan itself: rounds over a handful of rows then
    cost one job. What turns out larger is written like all else.
    ``drop`` removes tables that no later plan reads; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, local_bytes: int = 4 << 20, local_rows: int = 10_000):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/quern-{uuid.uuid4().hex}", {}
        self.local_bytes, self.local_rows = local_bytes, local_rows
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str = "t", local: bool = True, by: str | None = None) -> DataFrame:
        """``local=False`` writes at once, for frames that are costly to work out twice; ``by``
        writes a folder per value of a column of few values, so that reads of one skip the rest."""
        if local and df.columns and plan_bytes(df) <= self.local_bytes:
            held = df.limit(self.local_rows + 1).toArrow()
            if held.num_rows <= self.local_rows and held.nbytes <= self.local_bytes:
                out = self.spark.createDataFrame(held, df.schema)
                out._rows = held.num_rows
                return out
        path = f"{self.root}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = name
        out._scratch_path = path
        return out

    def part(self, frames: list[DataFrame], by: str, value: str) -> DataFrame:
        """The rows of several frames kept ``by`` a column that have one value of it, without
        that column, as one scan: a plan over many rounds stays as small as one over two."""
        schema = StructType([f for f in frames[0].schema.fields if f.name != by])
        paths = [p for p in (f"{df._scratch_path}/{by}={value}" for df in frames) if self._there(p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the JVM has gone
            pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size; an upper guess, never a measurement."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def rows_of(df: DataFrame) -> int:
    """The number of rows of a kept frame: known where it is local, else from the footers."""
    known = getattr(df, "_rows", None)
    return df.count() if known is None else known


def maybe_broadcast(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Hints a broadcast only where the optimizer's size estimate is within ``limit``;
    otherwise the plain frame, which Catalyst joins by shuffle."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, scan: bool = False) -> DataFrame:
    """Rows dealt evenly over at least all cores, ahead of work that CPU bounds and not
    bytes. For a plain ``scan`` only where its files give fewer tasks than there are cores,
    as a large table's never do."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if scan and df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
