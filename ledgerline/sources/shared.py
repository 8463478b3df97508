"""Where tables that cut a lineage are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master, as in tests; a cluster is refused,
    since its executors do not see a folder of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]
