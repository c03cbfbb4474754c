"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Workers import what the functions they run refer to; on a cluster, or where only the driver's
    own path has the package, they wouldn't find it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not itself inside an archive
        archive = Path(tempfile.mkdtemp(prefix="rasterloom-ship-")) / "rasterloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, Path("rasterloom") / file.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
