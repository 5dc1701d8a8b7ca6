"""Session construction and lineage cuts."""
from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app: str = "feedspark", cores: str | int | None = None, shuffle_partitions: int | None = None,
              driver_memory: str | None = None, options: dict[str, str] | None = None) -> SparkSession:
    """Session with the SQL settings every entry point here assumes.

    Master and number of shuffle partitions are the launcher's; tests and the bench, which run on one
    machine, pass ``cores``, ``shuffle_partitions`` and other ``options``.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if options:
        b = b.config(map=options)
    if cores is not None:
        b = b.master(f"local[{cores}]")
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Clusters name it. Where it is unset a local session (tests) uses a folder beside its warehouse; on a cluster
    that folder would be the driver machine's own, so there it is an error.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_feedspark_checkpoints"
    return d.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder and make it the session's checkpoint folder."""
    d = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Spark's setting that removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _writes = threading.Lock(), {}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While this is open, executions that start leave no shuffle files behind. For writes: what is written is read back from its
    files, while the shuffle files would stay until the driver's garbage collection finds them."""
    with _writing:
        depth, before = _writes.get(spark, (0, None))
        if not depth:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writes[spark] = depth + 1, before
    try:
        yield
    finally:
        with _writing:
            depth, before = _writes.pop(spark)
            if depth > 1:
                _writes[spark] = depth - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    The result survives executor loss (it lives in shared storage, not on an executor) and its
    plan is a plain file scan, so later stages get real size statistics (AQE join choice) and
    column pruning. This costs one job; ``DataFrame.checkpoint`` on an uncached plan would
    compute the plan twice (once for the eager count, once more to write the files).
    The table's files can be removed with ``drop_tables`` once nothing reads them any more; the shuffle files that led to it are
    removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedspark-tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and the values of ``aggregates`` over the rows, observed while they are written: no second scan."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, *[a.alias(name) for name, a in aggregates.items()]))
    return table, seen.get


def cut_all(*tables: DataFrame) -> list[DataFrame]:
    """``cut_lineage`` of independent tables, whose jobs run side by side."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        return list(pool.map(cut_lineage, tables))


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``cut_lineage`` that are read no more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        root = f"{shared_dir(spark)}/feedspark-tables/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/feedspark-tables/" in folder and folder.rpartition("/")[2] != "feedspark-tables":
                p = jvm.org.apache.hadoop.fs.Path(root + folder.rpartition("/")[2])
                p.getFileSystem(conf).delete(p, True)
