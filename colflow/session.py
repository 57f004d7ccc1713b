"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_written: list[str] = []
_tables: list[str] = []
_on_release: list[Callable[[SparkSession], None]] = []


def on_release(forget: Callable[[SparkSession], None]) -> Callable[[SparkSession], None]:
    """``forget(spark)`` is called by ``release``: whoever hands out frames over
    intermediate tables more than once drops them there."""
    _on_release.append(forget)
    return forget


def local_session(cores: str = "8", app: str = "colflow", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="colflow-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be removed by ``release``."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables and checkpoints of this session; frames
    that still read them become invalid."""
    for forget in _on_release:
        forget(spark)
    conf = spark._jsc.hadoopConfiguration()

    def delete(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)

    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    while _written:
        delete(_written.pop())
    # Spark gives each application a folder of its own for its checkpoints
    if (own := spark.sparkContext.getCheckpointDir()) is not None:
        delete(own)
        spark.sparkContext.setCheckpointDir(work_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: the plan so far is done and
    stored, and its partitioning stays known to the planner."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


# enough plans for a task to be worth starting, few enough for its memory
PLANS_PER_TASK = 2000


def plan_partitions(plans: DataFrame) -> int:
    """Partitions for work inside plans: by their number, and for few plans no
    more than there are cores to use."""
    count = plans.count()
    cores = plans.sparkSession.sparkContext.defaultParallelism
    return max(-(-count // PLANS_PER_TASK), min(cores, -(-count // 8)), 1)


# rows of lineage that a task sorts or groups, whatever the size of the corpus
ROWS_PER_TASK = 200_000


def row_partitions(rows: DataFrame) -> int:
    """Partitions for work on about as many rows as ``rows`` has: in proportion to
    them, and for few rows no more than there are cores to use. Counting a table only
    reads its footers."""
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-count // ROWS_PER_TASK), min(cores, -(-count // 10_000)), 1)


def deal(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """``df`` by the hash of ``keys`` in that many partitions, which adaptive execution
    does not merge: it merges by bytes as shuffled, and rows of repeated names take many
    times that in a sort. Without a number, ``df`` as it is."""
    return df if partitions is None else df.repartition(partitions, *keys)


@contextmanager
def partitioned_by_plan(spark: SparkSession, partitions: int):
    """Settings for work inside plans: joins, windows and aggregations keyed by
    (plan, ...) use a partitioning by plan, so a chain of them shuffles once.

    Rows of one plan are few, hence no skew for adaptive execution to mend,
    and with it off a checkpoint keeps its partitioning. Both join sides
    already lie together, so nothing is broadcast.
    """
    settings = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # a checkpoint hands its constraints on, and they would multiply by rounds
        "spark.sql.constraintPropagation.enabled": "false",
        # for a few thousand plans a core it takes longer to compile the stages than to run them
        "spark.sql.codegen.wholeStage": str(partitions > spark.sparkContext.defaultParallelism).lower(),
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the plan, and a lost executor
    costs a re-read instead of a re-run of everything before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], sort: bool = True, dealt: bool = False) -> DataFrame:
    """``materialize`` as a table bucketed (and sorted) by ``keys`` into as many
    buckets as there are shuffle partitions: joins and groups by the keys read it
    without an exchange. Rows are shuffled once for it, unless the caller says that
    they are ``dealt``: the rows of a task have few keys."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = f"default.{path.rsplit('/', 1)[-1].replace('-', '_')}"
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").option("path", path).bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if sort else writer).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


class BucketedRounds:
    """A table that grows by rounds: bucketed by all its columns, one partition for
    each round. Joins and anti-joins by whole rows read it without an exchange."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.columns, self.round = first.sparkSession, first.columns, -1
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = new_path(self.spark, name)
        self.table = f"default.{self.path.rsplit('/', 1)[-1].replace('-', '_')}"
        _tables.append(self.table)
        # the partition's name must not be one of the caller's
        self.mark = "_".join(["round", *self.columns])
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        """Appends ``rows`` as the next round; their number is ``last_rows``."""
        self.round += 1
        counted = Observation()
        dealt = rows.repartition(self.buckets, *self.columns).observe(counted, F.count(F.lit(1)).alias("n"))
        (
            dealt.withColumn(self.mark, F.lit(self.round))
            .write.format("parquet").mode("append").option("path", self.path)
            .partitionBy(self.mark).bucketBy(self.buckets, *self.columns).saveAsTable(self.table)
        )
        self.last_rows = counted.get["n"]

    def last(self) -> DataFrame:
        return self.spark.table(self.table).filter(F.col(self.mark) == self.round).drop(self.mark)

    def all(self) -> DataFrame:
        return self.spark.table(self.table).drop(self.mark)
