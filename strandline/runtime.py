"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
SPREAD_BYTES = 256 << 20

# Settings the operators are written for.  Shuffle width is left to AQE's
# coalescing, so a wide initial value is safe on a cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture for every Column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "strandline", cores: str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**DEFAULT_CONF, **conf}.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared working folder, ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder; a cluster
    session must name one, because executors cannot see each other's disks.
    """
    named = (spark.conf.get("spark.checkpoint.dir", None)
             or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
             or spark.sparkContext.getCheckpointDir())
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives the loss of executors, has a one-step plan, and is only
    computed once however often it is used.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``, sorted; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(target) if f.isDirectory())


class Rounds:
    """Tables of an iteration in the shared folder: each ``put`` writes one and reads it back.

    ``put`` deletes what earlier rounds wrote once the new table is complete, since nothing needs it any
    more; with ``keep`` the earlier tables stay until the next ``put`` without it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.old = spark, label, []

    def put(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            for done in self.old:
                drop_path(self.spark, done)
            self.old = []
        self.old.append(path)
        return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition the scan of a table of at most ``SPREAD_BYTES``.

    A small file of one row group would otherwise keep all text work on one core.  Larger tables are
    never shuffled by this, whatever the cluster's size.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size <= SPREAD_BYTES else df
