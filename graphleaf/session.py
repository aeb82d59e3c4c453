"""A session with the settings that the queries are planned for, and the package on its workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they import it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="graphleaf-package-")) / "graphleaf.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and no user interface; a cluster passes its own master and settings."""
    builder = SparkSession.builder.master(master).appName("graphleaf").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
