"""Places in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder's path under ``spark.checkpoint.dir`` that no other call gets; a local session without that setting is given one."""
    key, master = "spark.checkpoint.dir", spark.sparkContext.master
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strideline-")
        spark.conf.set(key, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
