"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_archweave_shipped"


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors once per Spark application.

    ``addPyFile`` uses Spark's own file distribution, so no folder need be shared with the driver.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="archweave-")) / "archweave_src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
