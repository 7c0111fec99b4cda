"""Sending the package to executors that don't have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import warnings

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package, as a zip file, to all executors of the session's application; once for each application.

    The driver's file server hands it out, so no folder has to be shared. It isn't needed where the package is installed.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="inkfold-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the file server reads it as executors come
    kept = os.path.join(folder, "package", os.path.basename(package))
    shutil.copytree(package, kept, ignore=shutil.ignore_patterns("__pycache__"))
    try:
        spark.sparkContext.addPyFile("file://" + shutil.make_archive(os.path.join(folder, "inkfold"), "zip", os.path.dirname(kept)))
    except Exception as why:  # noqa: BLE001  executors may have the package nevertheless
        warnings.warn(f"the package could not be sent to executors: {why}", stacklevel=2)
    _SHIPPED.add(application)
