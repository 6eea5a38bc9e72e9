"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from clipmill import storage

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers a copy of the package, once per application.

    Lets tasks run wherever the driver was started, without an installation on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    path = storage.join(storage.scratch_dir(spark, "package"), f"{package.name}.zip")
    storage.write_bytes(spark, path, packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
