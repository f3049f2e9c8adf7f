"""A session with the settings that the library is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "riverstone", master: str | None = None, **settings: str) -> SparkSession:
    """Settings are given with `_` for `.`, and win over the library's."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): str(v) for k, v in settings.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a context, unless PYTHONPATH names its folder."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_riverstone_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="riverstone-")) / "riverstone-package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted([*root.glob("riverstone/**/*.py"), *root.glob("corpus_pipeline.py")]):
            out.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    # What a stateful processor runs on the driver doesn't get added files, only the path that functions are sent with.
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [context.environment.get("PYTHONPATH"), str(path)]))
    context._riverstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riverstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/riverstone-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once in the shared folder and read back."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where its scan has fewer partitions than they are (a file of one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
