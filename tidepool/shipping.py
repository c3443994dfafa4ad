"""Make this package importable by the Python workers of a session's executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_tidepool_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidepool-code-"), "tidepool_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidepool", os.path.relpath(full, _ROOT)))
    context.addPyFile(path)
    context._tidepool_shipped = True
