"""A session with the settings that the library's results depend on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Results depend on the first two; the others size the work to the cluster at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "chronolith", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``, removed when the driver's JVM ends.

    Where the session names no such folder, one in the warehouse is used, which executors share too; in local mode,
    where there is one machine only, a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = "file://" + tempfile.mkdtemp(prefix="chronolith-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{root.rstrip('/')}/chronolith/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
