"""What a session needs before operators with Python workers run on it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors reach. Where it is unset, one of this machine's, but only for
    a session that runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = tempfile.mkdtemp(prefix="corvane-checkpoint-")
            atexit.register(shutil.rmtree, _folders[app], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_folders[app])
        folder = _folders[app]
    return folder


_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, for clusters on which it isn't installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane-package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(_PACKAGE):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
