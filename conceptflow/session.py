"""Session factory and the few session facts that every operator shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_SHELVES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "conceptflow") -> SparkSession:
    """A session with the settings that the engine expects (AQE on, UTC)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if Spark runs in one process, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="conceptflow-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def shelve(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: compressed and pruned by column, for wide or long tables.

    The table stays in the checkpoint folder of the application, whose owner clears it.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    shelved = df.sparkSession.read.parquet(path)
    _SHELVES[shelved] = path
    return shelved


def discard(*shelved: DataFrame) -> None:
    """Delete shelved tables that no later step reads."""
    for df in shelved:
        if path := _SHELVES.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
