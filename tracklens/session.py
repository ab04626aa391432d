"""Session settings shared by every job."""

import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the UTC session zone, on which every timestamp rule is defined, and ship this package to the workers."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the workers once per application, so Python functions load there from any folder.

    Stateful processors also start in a worker beside the driver, which sees no shipped files: functions and classes
    of the stream module travel by value.
    """
    streams = sys.modules.get("tracklens.streaming.jobs")
    if streams is not None:
        cloudpickle.register_pickle_by_value(streams)
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tracklens-package-"), "tracklens")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode where none is configured (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        current = context.getCheckpointDir()
        if not current and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = current if current else tempfile.mkdtemp(prefix="tracklens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
