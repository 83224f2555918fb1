"""Give the executors this package, so that Python functions are found by name there."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application once; a no-op on later calls."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for here, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="basalt-code-"), "basalt_code.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
