"""A folder that the driver and all executors share, for what queries write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset: in the warehouse, or on one machine (a local master) in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _OWN:
            alone = master.startswith("local") and not master.startswith("local-cluster")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="timberline-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        base = _OWN[app]
    return f"{base.rstrip('/')}/timberline/{label}-{uuid.uuid4().hex}"
