"""The package to the executors: Python workers import it by name."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the workers' path, once per application.

    Needed where executors don't have it installed; the archive is served by
    the driver, so no folder is shared for it.
    """
    application = spark.conf.get("spark.app.id")
    if application in _shipped:
        return
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
