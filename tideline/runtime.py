"""What a session needs before Python functions of this package can run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application, so that a cluster
    needs no installation of it. Spark's own file server hands the archive out."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = os.path.join(tempfile.mkdtemp(prefix="tideline-"), "tideline_src.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(_HERE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("tideline", os.path.relpath(path, _HERE)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
