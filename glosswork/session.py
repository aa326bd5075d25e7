"""Sessions: the package's own code for executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the session's executors, once an application, so that they need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="glosswork-")), "glosswork.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def kept(rows: DataFrame) -> DataFrame:
    """Rows that a plan reads several times: written to the cluster's spark.checkpoint.dir, where they outlive executors, or cached where none is set."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        return rows.persist()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return rows.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"{(root or tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
