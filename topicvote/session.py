"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_shipping = threading.Lock()


def get_session(app_name: str = "topicvote", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and times in UTC."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession | None = None) -> None:
    """Makes this package importable in the Python workers of the application, once. Driver
    threads that come meanwhile wait until it is there."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    with _shipping:
        if app not in _shipped:
            package = Path(__file__).resolve().parent
            target = Path(tempfile.mkdtemp(prefix="topicvote-")) / package.name
            archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
            spark.sparkContext.addPyFile(archive)
            _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="topicvote-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/topicvote/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialise``, bucketed and sorted by ``key``: tables with the same bucket count
    join on the key without a shuffle."""
    spark = df.sparkSession
    table = f"topicvote_{uuid.uuid4().hex}_{name}"
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", new_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)
