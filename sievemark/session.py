"""Session set-up and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievemark", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE); ``conf`` adds or overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Steps written by this process.
_STEPS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder, which
    goes with the process; on a cluster, where executors would each look into a folder of their own, this fails."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sievemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, and survives the loss of any executor: the files belong to none of them.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STEPS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> int:
    """Removes the steps this process has written, once no result is read any more; how many."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_STEPS)
    while _STEPS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STEPS.pop())
        p.getFileSystem(conf).delete(p, True)
    return n


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
