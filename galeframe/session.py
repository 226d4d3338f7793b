"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark import SparkContext, cloudpickle
from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with whoever submits the job.

    Functions sent to Python workers carry their code along, so executors need no copy of the package. Broadcast values do
    not: they have to be plain arrays and containers.
    """
    cloudpickle.register_pickle_by_value(sys.modules["galeframe"])
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the warehouse, which executors share too, where that is unset.

    The folders of a session are deleted when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tables"
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove_folders)
    _FOLDERS.append(folder)
    return folder


_FOLDERS: list[str] = []


def remove_folder(folder: str) -> None:
    """Delete a shared folder before the program ends."""
    path = SparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(SparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    _FOLDERS.remove(folder)


def _remove_folders() -> None:
    if SparkContext._jvm is None:
        return
    for folder in list(_FOLDERS):
        try:
            remove_folder(folder)
        except Exception:  # noqa: BLE001 - the JVM may have ended before
            return
